ODD = [
    (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one", "a"), (5, "one two", "b"), (None, "a null id with some words in it", "b"), (None, None, None),
    (6, "word " * 30_000, "a"), (7, "same text here twice over", "a"), (7, "same text here twice over", "a"), (8, "same text here twice over", "b"), (9, "x" * 200_000, "b"),
    (10, "日本語のテキスト und Größe ☃ café", "é"), (11, "\x1c\x1d odd\x85spaces\xa0here 12 34", "b"),
]
