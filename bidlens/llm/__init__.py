"""Operators that prepare text for training: counting, cleaning, scoring, joining and packing."""
