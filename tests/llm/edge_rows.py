"""Rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE_ROWS = [
    (1, "the cat and the dog are in the house of the king", "en", "b", 48),
    (1, "the cat and the dog are in the house of the king", "en", "b", 48),
    (2, "der hund und die katze sind in dem haus von dem mann", "de", "a", 52),
    (None, "der hund und die katze sind in dem haus von dem mann", "de", None, 52),
    (None, None, None, None, None),
    (3, None, "en", "a", None),
    (4, "", "de", "", 0),
    (5, "12 34 !? 56", None, "b", 11),
    (6, " \n\t\n ", "en", None, 5),
    (7, "é", "de", "c", 1),
    (8, "word " * 60_000, "en", "c", 300_000),
    (9, "x" * 200_000, None, "c", 200_000),
]
# names that operators use for columns of their own
CLASHES = ["score", "size", "key", "class", "target", "row_key", "anchor", "spans", "place", "chunk", "copies", "language", "repeats", "n_words", "_row_key", "_text_key", "__spans", "__left", "mix_place", "mix_source", "mix_copies", "__near_row", "__near_text", "chosen"]
