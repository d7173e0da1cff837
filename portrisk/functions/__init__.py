"""Column -> Column functions: scalars (T1-T14, P2, P3, P12, P14, P15) and HTML text."""
