"""Corrections of misread labels, states and digits: off by default, as raw text is what decisions rest on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: misread labels and what they mean, in the order in which they are replaced
LABEL_CORRECTIONS = {
    "aP Code": "Zip Code", "ZiP Code": "Zip Code", "Zip Gode": "Zip Code", "Zip C0de": "Zip Code", "ZIP C0de": "Zip Code", "Zp Code": "Zip Code",
    "Borrovver": "Borrower", "Borrewer": "Borrower", "B orrower": "Borrower", "Borr0wer": "Borrower", "Borrcwer": "Borrower",
    "0 wner": "Owner", "0wner": "Owner", "Ovvner": "Owner",
    "l.ender": "Lender", "Lendcr": "Lender", "Lend er": "Lender", "Lender/C1ient": "Lender/Client", "Lender/Cllent": "Lender/Client",
    "Ncighborhood": "Neighborhood", "Neighborh00d": "Neighborhood", "Neighb0rhood": "Neighborhood",
    "Counly": "County", "Coun ty": "County", "Ccnsus": "Census", "Censu5": "Census",
    "Assessor's Parce1": "Assessor's Parcel", "Assessors Parcel": "Assessor's Parcel", "APN Assessor": "Assessor's Parcel",
    "l.egal": "Legal", "Lega1": "Legal", "0ccupant": "Occupant", "Occupanl": "Occupant",
    "Sa1e": "Sale", "Sal e": "Sale", "S ale": "Sale", "Propert y": "Property", "Proper ty": "Property", "C0ntract": "Contract", "Conlract": "Contract",
    "Map Ref erence": "Map Reference", "Map Ref": "Map Reference", "lnspection": "Inspection", "Inspecti0n": "Inspection",
    "Financ1al": "Financial", "Financia1": "Financial", "Persona1": "Personal",
    "X]": "[X]", "]X[": "[X]", "|X|": "[X]", "><": "[X]",
}
# fixed values: states with a space inside
STATE_FIXES = {"G A": "GA", "C A": "CA", "T X": "TX", "F L": "FL", "N Y": "NY", "N C": "NC", "S C": "SC"}


def folded(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """struct(text, hits): ``text`` after all literal replacements in order, and how many of them had something to replace."""
    both = F.arrays_zip(F.lit([w for w, _ in pairs]).alias("wrong"), F.lit([r for _, r in pairs]).alias("right"))
    start = F.struct(text.alias("text"), F.lit(0).alias("hits"))
    step = lambda s, p: F.struct(F.replace(s["text"], p["wrong"], p["right"]).alias("text"), (s["hits"] + F.contains(s["text"], p["wrong"]).cast("int")).alias("hits"))
    return F.aggregate(both, start, step) if pairs else start


def corrected(text: Column) -> Column:
    """``text`` with labels, states and digits put right: O between digits or after $ is 0, l there is 1; null stays null.

    Replacements are literal and follow one another, so a label that holds its own misreading ("Map Reference" holds
    "Map Ref", "[X]" holds "X]") grows, as the service that this follows lets it.
    """
    fixed = folded(text, list(LABEL_CORRECTIONS.items()) + list(STATE_FIXES.items()))["text"]
    zeros = F.regexp_replace(fixed, r"(?<=[0-9$])O(?=[0-9])", "0")
    return F.regexp_replace(zeros, "(?<=[0-9$])l(?=[0-9])", "1")


def corrected_document(text: Column, learned: list[tuple[str, str]] = ()) -> Column:
    """struct(text, corrections) of a whole page: the fixed corrections, then the learned ones.

    Counted are the misread labels that the page holds and the learned pairs that had something to replace; states and
    digits are corrected without count. A null page stays null and counts none.
    """
    seen = F.size(F.filter(F.lit(list(LABEL_CORRECTIONS)), lambda w: F.contains(text, w)))
    after = folded(corrected(text), list(learned))
    return F.struct(after["text"].alias("text"), F.when(text.isNull(), 0).otherwise(seen + after["hits"]).alias("corrections"))
