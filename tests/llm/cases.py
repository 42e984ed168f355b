"""Rows that every operator has to take."""

# null, empty, white space only, short, repeated rows, a very long text
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (6, "a b c d e f g"), (None, "a b c d e f g"),
         (7, "word " * 30_000), (8, "Ünï cödé 日本   x")]
