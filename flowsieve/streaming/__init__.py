"""Fitted transforms on a stream of flow files.

Cleaning, scaling, the detector and the cascade work inside the row, so a
streaming frame takes the same expressions as a table; no state is kept.
"""
