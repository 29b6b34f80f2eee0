"""Texts that every operator must take: null, empty, blank, very long, repeated."""

ODD = [None, "", " ", "\n", "\n\n", "a", "é" * 12, "tab\tand  blanks ", "x" * 300_000, "word " * 30_000, "\U0001f642 emoji line here\nsecond", "same text twice over and over\nsame text twice over and over", "same text twice over and over"]
