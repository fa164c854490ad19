"""Residue letters, codes, structure symbols and identifiers as column expressions.

Codes 0-19 are residues in the order of LETTERS, 20 is any residue, 21 a gap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue order of profiles, structure letters.
LETTERS = "ARNDCQEGHILKMFPSTWYV"
ANY, GAP, END_GAP = 20, 21, 22
DSSP = "-HESTGBI"
PREDICTED = "-HEC"
EXPOSURE = "-ABCDE"
#: Letters that stand for another residue.
SAME = {"U": "C", "B": "D", "Z": "E"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def upper_ascii(text: Column) -> Column:
    return F.translate(text, _LOWER, _UPPER)


def as_row(text: Column) -> Column:
    """A text as an alignment row: letters as residues, every other character as a gap."""
    return F.regexp_replace(upper_ascii(text), "[^A-Z]", "-")


def code(letter: Column) -> Column:
    """Code of a residue letter (aa2i); -1 for white space, -2 for what is no residue."""
    up = F.translate(upper_ascii(letter), "".join(SAME), "".join(SAME.values()))
    at = F.instr(F.lit(LETTERS), up) - 1
    return (
        F.when(letter.isNull() | (letter == ""), None)
        .when(at >= 0, at)
        .when(up.isin("J", "O", "X"), ANY)
        .when(letter.isin("-", ".", "_"), GAP)
        .when(letter.isin(" ", "\t", "\n", "\r"), -1)
        .otherwise(-2)
        .cast("int")
    )


def letter(value: Column) -> Column:
    """Letter of a code (i2aa)."""
    return F.when(value.between(0, 19), F.substring(F.lit(LETTERS), value + 1, F.lit(1))).when(value == ANY, "X").when(value.isin(GAP, END_GAP), "-").otherwise("?")


def structure_code(symbol: Column, alphabet: str = DSSP) -> Column:
    """Code of a structure symbol (ss2i, sa2i); 0 for a gap, null for others."""
    at = F.instr(F.lit(alphabet), upper_ascii(symbol)) - 1
    return F.when(symbol.isin("-", ".", "_"), 0).when(at >= 0, at).cast("int")


def structure_letter(value: Column, alphabet: str = DSSP) -> Column:
    return F.when(value.between(0, len(alphabet) - 1), F.substring(F.lit(alphabet), value + 1, F.lit(1)))


def eight_to_three(symbol: Column) -> Column:
    """Eight-state structure to helix, strand, coil (ss2ss)."""
    up = upper_ascii(symbol)
    return F.when(up.isin("H", "E"), up).when(up.isin("G", "I"), "H").when(up == "B", "E").when(up.isin("S", "T", "C", " ", "~"), "C").otherwise("-")


def confidence_code(symbol: Column) -> Column:
    """Digits 0-9 to 1-10, gaps to 0 (cf2i)."""
    return F.when(symbol.rlike("^[0-9]$"), symbol.cast("int") + 1).when(symbol.isin("-", "."), 0).cast("int")


def confidence_symbol(value: Column) -> Column:
    return F.when(value == 0, "-").otherwise((value - 1).cast("string"))


def as_match(symbol: Column) -> Column:
    """Match form of a symbol: upper case, a dot as a dash."""
    return F.translate(symbol, _LOWER + ".", _UPPER + "-")


def as_insert(symbol: Column) -> Column:
    """Insert form of a symbol: lower case, a dash as a dot."""
    return F.translate(symbol, _UPPER + "-", _LOWER + ".")


def is_word(symbol: Column) -> Column:
    """Whether a symbol is a residue letter in either case."""
    return symbol.rlike("^[A-Za-z]$")


def match_count(row: Column) -> Column:
    """Match columns of an A3M row: upper-case letters and dashes."""
    return F.length(F.regexp_replace(row, "[^A-Z-]", ""))
