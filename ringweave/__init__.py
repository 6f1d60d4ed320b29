"""ringweave: exact algebraic search and classification on Spark DataFrames.

Numbers (a + b*sqrt2)/sqrt2^e, 6x6 matrices over them, two-bit residue patterns
and generator words are ordinary DataFrame columns. See README.md for the map.
"""
