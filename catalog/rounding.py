"""How results are rounded before engines are compared.

Two engines add up the same doubles in different orders, so the last digits differ.
"""

from __future__ import annotations

import re

PLACES = 6
# Averages and deviations of prices are around 1e5, where a double has some 1e-11 of noise:
# over millions of cells a few would fall on either side of the sixth place.
PRICE_PLACES = 3
PRICE_AGGREGATES = re.compile(r"feature_(cg|am)_(rmean|rstd|ewm|roll|rel_\w+_diff)")
# Means of simple fractions often end in an exact half of the last place. The offset moves
# them off that tie, so that the order of summation cannot decide which way they round.
OFF_TIE = 3.1e-8


def places(column: str) -> int:
    return PRICE_PLACES if PRICE_AGGREGATES.match(column) else PLACES
