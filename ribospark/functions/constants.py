"""Fixed values of molecular biology and of the file formats."""

from __future__ import annotations

# The genetic code in the order TCAG x TCAG x TCAG, by translation table number.
CODON_ORDER = "TCAG"
CODON_TABLES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    9: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    10: "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    12: "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    13: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    14: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    15: "FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    16: "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    21: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    22: "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    23: "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    24: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG",
    25: "FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    26: "FFLLSSSSYY**CC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    27: "FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    28: "FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    29: "FFLLSSSSYYYYCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    30: "FFLLSSSSYYEECC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    31: "FFLLSSSSYYEECCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    32: "FFLLSSSSYY*WCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    33: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG",
}
# IUPAC nucleotides, the bases they stand for, and their complements.
AMBIGUOUS_BASES = {"T": "T", "C": "C", "A": "A", "G": "G", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT_FROM = "ACGTURYKMBDHVacgturykmbdhv"
COMPLEMENT_TO = "TGCAAYRMKVHDBtgcaayrmkvhdb"
# One-letter codes of three-letter amino acids.
THREE_TO_ONE = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V"}
# The alphabet of composition reports.
ALPHABET = "ACDEFGHIKLMNPQRSTVWYBJOUXZ"
# Monoisotopic residue masses, and those of water and the proton.
RESIDUE_MASS = {"G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293, "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931, "U": 150.95364, "O": 237.14773}
WATER, PROTON = 18.010565, 1.007276
# Enzymes: (cleavage rule, PSI id, cleavage sites).
ENZYMES = {
    "Trypsin": ("(?<=[KRX])(?!P)", "MS:1001251", "KR"),
    "Arg-C": ("(?<=[RX])(?!P)", "MS:1001303", "R"),
    "Arg-C/P": ("(?<=[RX])", "", "R"),
    "Asp-N": ("(?=[DBX])", "MS:1001304", "DB"),
    "Asp-N/B": ("(?=[DX])", "", "D"),
    "Asp-N_ambic": ("(?=[DBEZX])", "MS:1001305", "DBEZ"),
    "Chymotrypsin": ("(?<=[FYWLJX])(?!P)", "MS:1001306", "FYWLJ"),
    "Chymotrypsin/P": ("(?<=[FYWLJX])", "", "FYWLJ"),
    "CNBr": ("(?<=[MX])", "MS:1001307", "M"),
    "Formic_acid": ("((?<=[DBX]))|((?=[DBX]))", "MS:1001308", "DB"),
    "Lys-C": ("(?<=[KX])(?!P)", "MS:1001309", "K"),
    "Lys-N": ("(?=[KX])", "", "K"),
    "Lys-C/P": ("(?<=[KX])", "MS:1001310", "K"),
    "PepsinA": ("(?<=[FLJX])", "MS:1001311", "FLJ"),
    "TrypChymo": ("(?<=[FYWLJKRX])(?!P)", "MS:1001312", "FYWLJKR"),
    "Trypsin/P": ("(?<=[KRX])", "MS:1001313", "KR"),
    "V8-DE": ("(?<=[DBEZX])(?!P)", "MS:1001314", "DBEZX"),
    "V8-E": ("(?<=[EZX])(?!P)", "MS:1001315", "EZX"),
    "leukocyte elastase": ("(?<=[ALIJVX])(?!P)", "MS:1001915", "ALIJVX"),
    "proline endopeptidase": ("(?<=[HKRX][PX])(?!P)", "MS:1001916", "HKRX"),
    "glutamyl endopeptidase": ("(?<=[DBEZX])", "MS:1001917", "DBEZX"),
    "alphaLP": ("(?<=[TASVX])", "", "TASVX"),
    "2-iodobenzoate": ("(?<=[WX])", "MS:1001918", "WX"),
    "iodosobenzoate": ("(?<=W)", "", "W"),
    "staphylococcal protease/D": ("(?<=[EZX])", "", "EZX"),
    "proline-endopeptidase/HKR": ("(?<=[PX])", "", "PX"),
    "Glu-C+P": ("(?<=[DBEZX])(?!P)", "", "DBEZX"),
    "PepsinA + P": ("(?<=[FLJX])(?!P)", "", "FLJX"),
    "cyanogen-bromide": ("(?<=[MX])", "", "MX"),
    "Clostripain/P": ("(?<=[RX])", "", "RX"),
    "elastase-trypsin-chymotrypsin": ("(?<=[ALIVKRWFYX])(?!P)", "", "ALIVKRWFYX"),
    "unspecific cleavage": ("(?<=[A-Z])", "MS:1001956", ""),
}
# Variant classes of mutation tables that change a protein.
PROTEIN_CLASSES = ("Frame_Shift_Del", "Frame_Shift_Ins", "In_Frame_Del", "In_Frame_Ins", "Missense_Mutation", "Nonsense_Mutation")
